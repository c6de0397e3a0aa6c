hashlib.md5(x)
