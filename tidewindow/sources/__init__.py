"""Readers of listings: tables, grids, embedded JSON, banners and rate texts."""
