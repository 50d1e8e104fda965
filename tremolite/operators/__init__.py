"""Part of tremolite; see README.md."""
