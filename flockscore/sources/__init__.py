"""Reading and writing: tweets, reference tables, exports."""
