"""The queries over the driver's tables; importing a module here registers its queries."""
