"""sources of the quillstone package."""
