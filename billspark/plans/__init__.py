"""Query plans that the entry point registers, each with its SQL where SQL can say it."""
