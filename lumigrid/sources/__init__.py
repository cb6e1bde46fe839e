"""Readers of images, folders and JSON maps, and writers of JSON, tables and manifests."""
