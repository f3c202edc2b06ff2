"""The marketplace workload is batch only: no operator here reads or keeps a stream."""
