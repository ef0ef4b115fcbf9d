"""From rules to plans: static analysis, and rule bodies as joins."""
