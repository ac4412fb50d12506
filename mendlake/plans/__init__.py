"""plans of the mendlake library."""
