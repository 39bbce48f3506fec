"""Order-dependent plans: one pure capture step, shared by batch and streaming."""
