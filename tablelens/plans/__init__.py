"""Analysis plans: validation, defaults, running, and the registered queries."""
