"""What can be asked of matching events: pages, counts and histograms, facets, exports."""
