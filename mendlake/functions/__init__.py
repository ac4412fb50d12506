"""functions of the mendlake library."""
