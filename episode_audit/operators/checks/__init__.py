"""Quality checks over frame series."""
