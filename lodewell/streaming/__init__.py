"""Streaming forms: resumable surface scans, evidence logs as they grow, history version by version."""
