"""End-to-end plans: the star build, the query registry and its SQL oracle."""
