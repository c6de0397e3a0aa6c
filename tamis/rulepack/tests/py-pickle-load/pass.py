unpickled = 1
