"""Part of weftmill; see the README."""
