"""Raw file contract, readers, writers, stored tables and the test-table binding."""
