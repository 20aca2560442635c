"""End-to-end plans and the registered queries with their check SQL."""
