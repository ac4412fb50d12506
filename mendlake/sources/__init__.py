"""sources of the mendlake library."""
