"""Readers: session logs, quota payloads, price files, quota history."""
