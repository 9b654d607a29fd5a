"""Vehicle-identifier decoding and corpus analytics on PySpark."""
