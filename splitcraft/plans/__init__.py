"""Query plans: fixture views and the catalog of registered queries."""
