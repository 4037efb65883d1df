"""Readers, sinks and the adapters that bind warehouse tables to the pull-request model."""
