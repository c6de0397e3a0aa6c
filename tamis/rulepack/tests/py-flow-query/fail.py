q = request.args.get('q')
cursor.execute(q)
