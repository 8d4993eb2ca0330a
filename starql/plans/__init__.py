"""Plan tools: canonical predicates, physical plans as text, cost, search over alternatives, reachability.

None of this is on the execution path: queries run through Catalyst."""
