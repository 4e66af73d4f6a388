"""The trial log as a stream."""
