"""streaming of the mendlake library."""
