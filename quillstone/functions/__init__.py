"""functions of the quillstone package."""
