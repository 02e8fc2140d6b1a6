"""Part of the textcohort package."""
