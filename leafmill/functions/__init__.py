"""Part of leafmill; see README.md."""
