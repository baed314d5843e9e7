"""Runnable jobs over the engine's operators; each is a function taking a session, with a command line around it."""
