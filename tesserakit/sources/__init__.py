"""Files into parsed documents."""
