"""Readers and writers of snapshots, settings, features and rates."""
