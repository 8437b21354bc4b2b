"""streaming of the quillstone package."""
