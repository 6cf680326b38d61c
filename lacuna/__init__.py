"""Spatial coverage analytics and site placement as Spark plans."""
