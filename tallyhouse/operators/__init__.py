"""Inventory questions, each as a DataFrame in and a DataFrame out."""
