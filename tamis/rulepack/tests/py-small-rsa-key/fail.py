rsa.generate_private_key(65537, key_size=1024)
