eval(user_text)
