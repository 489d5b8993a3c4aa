"""Inputs and outputs: envelopes and change logs, manifests, a versioned table."""
