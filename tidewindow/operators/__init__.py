"""DataFrame stages: forecasts, routes, the ledger, evaluation, rules and the directory."""
