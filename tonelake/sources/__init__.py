"""Readers and writers: preset files, catalogs, audio and measurement documents."""
