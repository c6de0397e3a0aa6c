GRANT SELECT ON t TO u;
