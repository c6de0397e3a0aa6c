def f():
    c = input()
    os.system(c)
