"""tidelog: a Spark-native engine over an hour-partitioned log of chat-API traffic.

Sub-packages
    functions  Column expressions (decoding, JSON, event streams, chat schemas)
    operators  DataFrame -> DataFrame building blocks
    sources    readers and writers of the log, the dataset, the archive and the routes
    streaming  Structured Streaming jobs
    plans      registered queries over the given tables
"""
