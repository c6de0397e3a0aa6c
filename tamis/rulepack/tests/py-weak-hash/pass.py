hashlib.sha256(x)
