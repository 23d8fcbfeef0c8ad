"""Plans made of several steps: replaying a change log."""
