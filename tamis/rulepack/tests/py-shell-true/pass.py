subprocess.run([cmd], shell=False)
