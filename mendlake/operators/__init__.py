"""operators of the mendlake library."""
