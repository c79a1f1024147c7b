"""Files in and out: gene tracks, stored analyses with checksums, CSV tables, evidence facts."""
