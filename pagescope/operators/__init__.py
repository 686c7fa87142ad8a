"""Relations over files and operations on them."""
