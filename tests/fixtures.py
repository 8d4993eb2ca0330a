"""Small tables of the tests."""

USERS = [(1, 33), (2, 64), (3, 123), (4, 11), (5, 1), (6, 5), (7, 88), (8, 64), (8, 64), (10, 22), (11, 64), (12, 64), (13, 33), (14, 64), (15, 443), (16, 21), (17, 18)]
EMPLOYEES = [(1, 3), (2, 6), (3, 12), (4, 11), (5, 1), (6, 5), (33, 31), (66, 32), (67, 33), (68, 34), (69, 35)]
FILES = {
    "users": "id:int,age:int\n" + "".join(f"{a},{b}\n" for a, b in USERS),
    "books": "id:int,price:int\n1,100\n2,200\n3,300\n",
    "departments": "id:int\n1\n2\n3\n4\n5\n",
    "employees": "id:int,department_id:int\n" + "".join(f"{a},{b}\n" for a, b in EMPLOYEES),
    "markets": 'id:int,region:string,note:string\n1,AMERICA,"North, South"\n2,EUROPE,"say ""hi"""\n3,ASIA,\n',
    "a": "id:int,v:int\n1,10\n1,11\n2,20\nNULL,99\n",
    "b": 'id:int,w:int\n1,100\n1,101\n3,300\n"NULL",999\n',
    "lhs": "name:string,v:int\nalpha,1\nbeta,2\n",
    "rhs": "name:string,w:int\nalpha,10\ngamma,30\n",
    "departments_4000": "id:int\n" + "".join(f"{k}\n" for k in range(1, 4001)),
}


def write_files(folder) -> str:
    for name, text in FILES.items():
        (folder / f"{name}.csv").write_text(text)
    (folder / "constraints.meta").write_text("# keys\nunique departments id\nforeign_key employees department_id departments id\n")
    (folder / "indexes.meta").write_text("users id sorted users.id.idx\n")
    return str(folder)
