"""Sources and sinks: records from files, services, commands and reports; facts from records; codecs and exports.

Every source gives a table (record_no bigint, body string), a body being one
JSON object.
"""
