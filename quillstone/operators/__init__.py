"""operators of the quillstone package."""
