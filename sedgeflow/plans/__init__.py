"""Physical plans: session settings, layout, what a plan reads and shuffles."""
