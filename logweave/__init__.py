"""logweave: log analytics as Spark jobs.

Every operator takes DataFrames and returns DataFrames; nothing keeps a session,
and nothing but bounded model tables ever reaches the driver.
"""
