q = int(request.args.get('q'))
cursor.execute('select 1')
