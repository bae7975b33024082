"""Graph operators: pattern matching, updates, selections, reachability."""
