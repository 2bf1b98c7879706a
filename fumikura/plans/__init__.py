"""The three flows: harvest, mining, curation."""
