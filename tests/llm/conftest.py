"""The session comes from the folder above, so that all tests share one."""
