evaluate = 1
