def f():
    c = shlex.quote(input())
    os.system(c)
