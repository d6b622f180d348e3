"""Part of folioscope; see the README for the layout."""
