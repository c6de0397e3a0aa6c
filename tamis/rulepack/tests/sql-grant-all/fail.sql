GRANT ALL ON t TO u;
