"""Recommenders: fit on interactions, predict (uid, iid, score)."""
