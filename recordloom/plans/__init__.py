"""End-to-end matching plans and the registered queries."""
