x = yaml.load(data, Loader=yaml.SafeLoader)
