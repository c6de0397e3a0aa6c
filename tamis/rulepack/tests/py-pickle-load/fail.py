import pickle
pickle.loads(x)
