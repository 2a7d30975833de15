"""Plan-level helpers: shipping of the package, plan inspection."""
