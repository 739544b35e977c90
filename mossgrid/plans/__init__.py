"""Session set-up, run-time helpers and the registered queries."""
