subprocess.run(cmd, shell=True)
