"""plans of the quillstone package."""
