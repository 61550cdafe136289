"""Reading uploads and rules, writing caches and exports."""
