"""Operators over log items: folds, reads, state, garbage collection, recovery, integrity."""
