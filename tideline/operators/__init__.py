"""DataFrame operators, one module per analytic stage."""
