x = yaml.load(data)
