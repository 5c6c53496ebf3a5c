"""Part of kinforge."""
