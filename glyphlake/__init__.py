"""glyphlake: text-recognition quality analytics and corpus preparation on PySpark."""
