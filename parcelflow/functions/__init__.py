"""Column functions: values, carriers, validation and label text."""
