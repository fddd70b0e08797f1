"""The series handle, options and the workspace."""
