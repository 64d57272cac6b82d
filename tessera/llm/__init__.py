"""Operators for large text corpora; nothing outside this package imports it. Ids are bigints: null ones and those that are no numbers keep their rows."""
